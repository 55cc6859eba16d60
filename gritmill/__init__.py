"""gritmill: a Spark-native analytics engine for code- and configuration-review findings."""
