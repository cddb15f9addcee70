"""Content intelligence on Spark: operators are plain DataFrame -> DataFrame functions."""
