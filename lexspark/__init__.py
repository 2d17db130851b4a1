"""lexspark: subword vocabularies and text pipelines on Spark."""
