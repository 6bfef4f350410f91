"""feedloom: a Spark-native content and event intelligence engine."""
