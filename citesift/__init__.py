"""Document screening on Spark: retrieve, label, featurise, rank and export."""
