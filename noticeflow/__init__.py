"""noticeflow: Spark-native operators over tables and streams of public notices."""
