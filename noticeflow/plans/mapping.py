"""The mapping run: which platform each organisation's notices are on, from stored pages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators.platforms import fill_website, pending_mapping, resolve_platform
from noticeflow.operators.ranking import limit_ordered, rotate
from noticeflow.sources.registry import assert_wellformed, extract_funded_rows, order_progressive, preserve_mapping


def map_registry(registry: DataFrame, registry_pages: DataFrame, pages: DataFrame, refresh: bool = False) -> DataFrame:
    """Registry with website and platform filled for pending rows, the others untouched."""
    pending = pending_mapping(registry, refresh)
    mapped = resolve_platform(fill_website(pending, registry_pages), pages)
    kept = registry.join(pending.select("school_code"), "school_code", "left_anti")
    return kept.select(*registry.columns).unionByName(mapped.select(*registry.columns))


def build_registry(page_texts: DataFrame, earlier: DataFrame) -> DataFrame:
    """Funded-list page texts -> ordered registry that keeps earlier mappings."""
    fresh = preserve_mapping(extract_funded_rows(page_texts), earlier)
    return order_progressive(assert_wellformed(fresh))


def run_order(registry: DataFrame, ordinal: str, start: int, limit: int | None = None) -> DataFrame:
    """Mapped organisations in polling order: the first ``limit``, else all rotated to the checkpoint.

    ``ordinal`` is the 1-based position among the mapped rows.
    """
    if limit:
        return limit_ordered(registry, limit, ordinal).withColumn("run_order", F.col(ordinal) - 1)
    return rotate(registry, ordinal, start, registry.count())
