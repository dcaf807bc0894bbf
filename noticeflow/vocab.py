"""Term lists, labels, patterns and limits.

Everything in this module is data, not logic.  The values are fixed because results
depend on them verbatim; callers can pass their own lists to every operator.
"""

from types import SimpleNamespace


# --- fixed values: programme and call vocabulary -------------------------------------
PROJECT_CONTEXT_TERMS = (
    "dm 219/2025", "d.m. 219/2025", "dm 219_2025", "d.m. 219", "dm219", "dm 219",
    "219/2025", "219_2025", "avviso 73226/2026", "73226/2026",
    "m4c1i2.1", "m4c1i2.1-2026-1745", "snodi formativi", "snodo formativo",
    "intelligenza artificiale", "educare all'i.a.", "educare all’i.a.", "educare all'ia",
    "educare all’ia", "educare alla i.a.", "educare all ia",
)

CALL_TERMS = (
    "avviso pubblico", "avviso di selezione", "procedura di selezione",
    "procedura per la selezione", "procedura selettiva", "selezione esperti",
    "esperti formatori", "esperto formatore", "esperto", "esperti", "formatore",
    "formatori", "tutor", "reclutamento", "percorsi formativi", "laboratori formativi",
    "percorsi e laboratori formativi", "figure professionali", "operatori economici",
    "operatore economico", "manifestazione di interesse", "manifestazione d'interesse",
    "indagine di mercato", "affidamento diretto", "servizi di formazione", "mepa",
    "capitolato", "disciplinare", "presentazione candidatura", "istanza di partecipazione",
    "domanda di partecipazione", "richiesta disponibilita", "richiesta disponibilità",
    "candidatura",
)

CALL_CORE_TERMS = (
    "avviso pubblico", "avviso di selezione", "procedura di selezione",
    "procedura per la selezione", "procedura selettiva", "selezione esperti",
    "esperti formatori", "esperto formatore", "esperti esterni", "formatori esterni",
    "reclutamento esperti", "reclutamento tutor", "reclutamento formatori",
    "avviso di reclutamento", "figure professionali", "operatori economici",
    "operatore economico", "manifestazione di interesse",
    "manifestazione d'interesse operatori economici", "indagine di mercato",
    "mepa", "istanza di partecipazione", "domanda di partecipazione",
    "presentazione candidatura", "richiesta disponibilita",
)

WEAK_PREFILTER_TERMS = (
    "avviso", "selezione", "formazione", "affidamento", "affidamento diretto",
    "capitolato", "disciplinare", "bandi", "gare", "contratti", "determina",
    "determine", "allegato a", "griglia di valutazione",
)

STRONG_PREFILTER_TERMS = PROJECT_CONTEXT_TERMS + (
    "operatori economici", "operatore economico", "manifestazione di interesse",
    "indagine di mercato", "rdo", "mepa", "esperti esterni", "formatori esterni",
    "incarico esterno", "ente di formazione", "enti di formazione", "soggetti giuridici",
    "soggetti qualificati", "procedura di selezione", "procedura per la selezione",
    "procedura selettiva", "avviso di selezione", "istanza di partecipazione",
    "domanda di partecipazione", "richiesta disponibilita", "richiesta disponibilità",
    "percorsi e laboratori formativi", "reclutamento esperti", "reclutamento tutor",
    "reclutamento formatori", "avviso di reclutamento", "selezione di esperti",
    "selezione di tutor", "individuazione di tutor", "individuazione di esperti",
    "individuazione tutor", "individuazione esperti",
)

# --- fixed values: rejecting vocabulary ----------------------------------------------
NEGATIVE_TERMS = (
    "graduatoria definitiva", "graduatoria provvisoria", "graduat", "pubblicazione graduatoria",
    "pubblicaz. graduat", "decreto pubblicazione graduatoria", "verbale commissione",
    "verbale apertura", "apertura candidature", "nomina commissione",
    "determina", "determinazione", "decisione a contrarre", "decisione affid",
    "fornitura", "forniture", "acquisto", "consumabili", "cancelleria",
    "materiale igienico", "elettrodi", "cambridge", "accordo sindacale",
    "riunioni e collegi", "commissione liceo", "studenti", "studente",
    "acfdg", "acprot",
    "nomina rup", "incarico rup", "supporto tecnico", "supporto al rup", "supporto tecnico al rup",
    "responsabile unico del progetto", "assunzione in bilancio", "assunzione al bilancio",
    "decreto assunzione in bilancio", "decreto assunzione al bilancio",
    "disseminazione", "azione di disseminazione", "azione di disseminazione iniziale",
    "pubblicita", "lettera di incarico", "decreto di incarico", "decreto di nomina",
    "conferimento incarico", "conferimento incarich", "aggiudicazione", "determina di aggiudicazione",
    "determinazione di aggiudicazione", "determina cuc", "determinazione cuc",
    "schema di contratto", "contratto",
)

STRONG_NEGATIVE_TERMS = (
    "graduatoria", "graduat", "pubblicazione graduatoria", "pubblicaz. graduat", "aggiudicazione",
    "verbale", "verbale apertura", "apertura candidature", "nomina commissione",
    "determina", "determinazione", "decisione a contrarre", "decisione affid",
    "fornitura", "forniture", "acquisto", "consumabili",
    "materiale igienico", "elettrodi", "cambridge", "accordo sindacale",
    "riunioni e collegi", "commissione liceo", "studenti", "studente",
    "acfdg", "acprot",
    "commissione valutazione", "assunzione in bilancio", "assunzione al bilancio",
    "decreto assunzione in bilancio", "decreto assunzione al bilancio",
    "disseminazione", "azione di informazione", "azione di disseminazione",
    "azione di disseminazione iniziale", "comunicazione e disseminazione",
    "decreto di assegnazione incarico", "decreto di assegnazione dell'incarico",
    "decreto di assegnazione degli incarichi", "assegnazione incarich",
    "conferimento incarico", "conferimento incarich",
    "assunzione incarico", "assunzione dell'incarico", "atti di nomina",
    "lettera di incarico", "decreto di incarico", "decreto di nomina", "nomina rup",
    "incarico rup", "supporto tecnico", "supporto al rup", "supporto tecnico al rup",
    "responsabile unico del progetto",
    "determina cuc", "determinazione cuc", "schema di contratto", "contratto",
    "dichiarazione rup", "dichiarazione del rup",
)

INTERNAL_TERMS = (
    "personale interno", "docenti interni", "docente interno", "esperti interni",
    "tutor interni", "personale docente interno", "personale ata", "figure professionali interne",
    "rivolto a personale interno", "avviso interno", "in servizio presso questa",
    "riservat", "selezione interna",
)

EXTERNAL_TERMS = (
    "esterno", "esterni", "esperti esterni", "formatori esterni", "personale esterno",
    "operatore economico", "operatori economici", "ente di formazione", "enti di formazione",
    "soggetti giuridici", "soggetti qualificati",
    "collaborazione plurima", "collaborazione esterna", "mepa",
)

RESULT_MARKERS = (
    "graduat", "decreto affidamento", "decreto di affidamento",
    "aggiudicazione", "esito procedura", "esito selezione", "esito della selezione",
)

ROLE_TERMS = (
    "esperto", "esperti", "tutor", "formatore", "formatori", "docente", "docenti",
    "ata", "assistente amministrativo", "collaboratore", "collaboratori",
    "referente", "coordinatore", "project manager", "rup", "dirigente scolastico",
)

# --- fixed values: patterns over normalised text ---------------------------------------
ROLE_ASSIGNMENT = r"(?U)decreto di assegnazione\b(?:\s+\S+){0,6}\s+dell.incarico"
STANDALONE_DECLARATION = (
    r"(?U)dichiarazione\b.{0,60}(insussistenza|conflitt\w*.{0,5}interess\w*|incompatibilit|inesistenza)"
    r"|documento di stipula"
)
AUTHORISATION_REQUEST = r"(?U)richiesta autorizzazione\b(?:\s+\S+){0,6}\s+incarico"
EXTERNAL_FALLBACK_ONLY = (
    r"indire nuovo avviso oppure ricercare all.esterno"
    r"|per le figure mancanti,?\s*all.esterno della istituzione scolastica"
    r"|esigenza di ricorrere a soggetti esterni"
)
EXTERNAL_ELIGIBILITY = (
    r"in via subordinata|risultati ammessi|per esterni\s*:|partita iva"
    r"|lavoro autonomo|prestazione occasionale|interne ed esterne|interni ed esterni"
)
APPLICANT_CHECKBOX = r"dipendente di altra p\.a\.,?\s*(?:o|ovvero)\s*se\s*[eè]\s*esperto esterno"
APPLY_INSTRUCTION = (
    r"presentare\s+(?:la\s+)?(?:propria\s+)?candidatura|inviare\s+(?:la\s+)?(?:propria\s+)?istanza|"
    r"domanda\s+di\s+partecipazione|modalita\s+di\s+partecipazione|come\s+presentare|"
    r"indirizzo\s+(?:email|mail|pec)|entro\s+(?:e\s+non\s+oltre\s+)?le\s+ore|entro\s+il\s+\d"
)
AUTHORISING_ONLY = (
    r"si\s+autorizza\s+l.avvio|autorizza\s+l.avvio\s+della\s+procedura|"
    r"decreta\s+di\s+autorizzare|si\s+decreta\s+l.avvio"
)
WEAK_APPLICATION = (
    r"domanda|candidatura|istanza|presentare|inviare|iscrizione|modalita\s+di\s+partecipazione"
)
PROTOCOL = r"prot(?:ocollo)?\.?\s*n?\.?\s*(\d+)\s*del\s*(\d{1,2}[/.]\d{1,2}[/.]\d{2,4})"

# --- fixed values: reasons added to the strong-negative hits -----------------------------
HIT_ROLE_ASSIGNMENT = "decreto di assegnazione ... dell'incarico"
HIT_STANDALONE_DECLARATION = "dichiarazione/documento di stipula standalone (titolo)"
HIT_AUTHORISATION_REQUEST = "richiesta autorizzazione incarico (titolo)"

# --- fixed values: date vocabulary --------------------------------------------------------
MONTHS_IT = (
    "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno",
    "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre",
)
WEEKDAYS_IT = ("lunedi", "martedi", "mercoledi", "giovedi", "venerdi", "sabato", "domenica")
PLAUSIBLE_YEARS = (2020, 2035)

# --- fixed values: crawling -----------------------------------------------------------------
SECTION_TERMS = (
    "albo", "amministrazione-trasparente", "bandi", "gare", "contratti",
    "pnrr", "avvisi", "determine", "determina", "esperti", "mepa",
)
CANDIDATE_TERMS = (
    "cup", "clp", "dm 219", "dm 219_2025", "d.m. 219", "219/2025", "219_2025",
    "73226/2026", "m4c1i2.1", "m4c1i2.1-2026-1745", "pnrr",
    "intelligenza artificiale", "snodi formativi", "snodo formativo",
    "educare all'i.a.", "educare all’ia", "procedura di selezione",
    "procedura per la selezione", "avviso di selezione", "esperto", "esperti",
    "formatore", "formatori", "tutor", "operatori economici", "operatore economico",
    "manifestazione di interesse", "indagine di mercato", "rdo", "mepa",
    "istanza di partecipazione", "domanda di partecipazione", "richiesta disponibilita",
    "richiesta disponibilità", "percorsi formativi", "laboratori formativi",
    "percorsi e laboratori formativi",
)
NOISE_TERMS = ("privacy", "cookie", "accessibilita", "mailto:", "tel:", "facebook.com", "instagram.com")

TARGET_CATEGORY = "Bandi di gara e contratti"
NAVIGATION_LABELS = (
    "Disposizioni generali", "Organizzazione", "Consulenti e collaboratori", "Personale",
    "Bandi di concorso", "Performance", "Enti Controllati", "Attività e procedimenti",
    "Provvedimenti", "Bandi di gara e contratti",
    "Sovvenzioni, contributi, sussidi, vantaggi economici", "Bilanci",
    "Beni immobili e gestione patrimonio", "Controlli e rilievi sull'amministrazione",
    "Servizi erogati", "Pagamenti dell'amministrazione", "Opere Pubbliche",
    "Pianificazione e governo del territorio", "Informazioni ambientali",
    "Interventi straordinari e di emergenza", "Altri contenuti",
    "Piano triennale per la prevenzione della corruzione e della trasparenza",
    "Atti generali", "Oneri informativi per cittadini e imprese",
    "Riferimenti normativi su organizzazione e attività", "Atti amministrativi generali",
    "Documenti di programmazione strategico-gestionale", "Codice disciplinare e di condotta",
)

# --- fixed values: platform fingerprints ---------------------------------------------------------
SPAGGIARI_ID = (
    r"web\.spaggiari\.eu/sdg2/(?:AlboOnline|Trasparenza)/([A-Za-z0-9]+)"
    r"|albo_pretorio\.php\?sede_codice=([A-Za-z0-9]+)"
    r'|custcode"\s*:\s*"([A-Za-z0-9]+)"'
)
ARGO_ID = r"(?i)albipretorionline\.com/([A-Za-z0-9]+)|customerCode=([A-Za-z0-9]+)"
NUVOLA_MARK = "madisoft"
ALBO_LINK = (
    r'(?i)href="([^"]*(?:albo[-/]?(?:online|pretorio)|amministrazione[-/]?trasparente'
    r'|tipologia-documento/albo)[^"]*)"'
)
WEBSITE_LINK = r'[Ss]ito\s*web[^<]*</[^>]+>\s*<[^>]+>\s*<a[^>]+href="([^"]+)"'
EDU_URL = r"""https?://[^\s"'<>]*\.edu\.it[^\s"'<>]*"""
SPAGGIARI_BASE = "https://web.spaggiari.eu/sdg2/AlboOnline"
NUVOLA_BOARD = "https://nuvola.madisoft.it/bacheca-digitale/bacheca/{code}/5/IN_PUBBLICAZIONE/0/show"

# --- fixed values: funded-list rows ----------------------------------------------------------------
REGIONS = (
    "TRENTINO-ALTO ADIGE", "FRIULI VENEZIA GIULIA", "EMILIA-ROMAGNA",
    "VALLE D'AOSTA", "ABRUZZO", "BASILICATA", "CALABRIA", "CAMPANIA",
    "LAZIO", "LIGURIA", "LOMBARDIA", "MARCHE", "MOLISE", "PIEMONTE",
    "PUGLIA", "SARDEGNA", "SICILIA", "TOSCANA", "UMBRIA", "VENETO",
)
FUNDED_ROW_FIELDS = (
    ("progressive", r"\d+"),
    ("area", r"Mezzogiorno|Centro\s+-\s+Nord"),
    ("school_code", r"[A-Z]{2}[A-Z0-9]{8}"),
    ("school_name", r".+?"),
    ("region", "|".join(REGIONS)),
    ("school_type", r"Statale|Paritaria"),
    ("date", r"\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}:\d{2}"),
    ("cup", r"[A-Z0-9]{15}"),
    ("clp", r"M4C1I2\.1-\d{4}-\d+-P-\d+"),
    ("amount", r"[\d.\s]+,\d{2}"),
)
FUNDED_ROW_END = r"\s*€"

# --- fixed values: search ----------------------------------------------------------------------------
SEARCH_QUERY_TERMS = (
    "albo pretorio DM 219 M4C1I2.1 snodi formativi intelligenza artificiale "
    "avviso selezione esperti tutor operatori economici"
)
SEARCH_ENGINE_HOST = "duckduckgo.com"

# --- fixed values: limits ------------------------------------------------------------------------------
KIND_WINDOW_CHARS = 2000
CANDIDATE_WINDOW_CHARS = 3000
PAGE_TEXT_CHARS = 4000
SCORING_TEXT_CHARS = 20000
ERROR_CHARS = 300
REASON_CHARS = 400
MIN_USABLE_CHARS = 80
MAX_REPLACEMENT_RATIO = 0.02
MAX_PAGES_PER_SITE = 12
MAX_ATTACHMENTS = 3
MAX_SEARCH_RESULTS = 8
SEARCH_WINDOW_DAYS = 7
ALERT_LEASE_MINUTES = 120
THREAD_TTL_DAYS = 60
ROLE_MATCH_DAYS = 5
NEAREST_THREAD_DAYS = 30

# --- fixed values: reasons of decisions ------------------------------------------------------------------
SEND_FAILED_REASON = "Confirmed and grouped, but AlertService.send() did not succeed."

# --- fixed values: displayed words -----------------------------------------------------------------------
CONFIDENCE_IT = {"high": "alta", "medium": "media", "low": "bassa"}
UNKNOWN_DEADLINES = ("", "unknown", "sconosciuto", "non specificata", "non specificato")
STATUS_OPEN, STATUS_EXPIRED, STATUS_UNKNOWN = "aperta", "scaduta", "scadenza sconosciuta"
DEFAULT_TYPE, DEFAULT_DEADLINE = "sconosciuto", "non specificata"


def own(**lists) -> SimpleNamespace:
    """These values with some replaced by the caller's, for every operator that takes ``terms``."""
    unknown = lists.keys() - globals().keys()
    if unknown:
        raise KeyError(f"no such lists: {sorted(unknown)}")
    return SimpleNamespace(**{k: v for k, v in globals().items() if k.isupper()} | lists)
