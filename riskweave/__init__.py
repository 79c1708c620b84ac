"""Code-risk analytics on Spark: source corpora in, findings and risk reports out."""
