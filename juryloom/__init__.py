"""juryloom: Spark-native multi-rater labelling of dialogue corpora, as DataFrame transformations."""
