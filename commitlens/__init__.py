"""commitlens: Spark-native analytics over package histories, code graphs and verdict labels."""
