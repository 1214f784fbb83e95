"""waymark: a Spark-native engine for curating places and composing outings."""
