"""Document intelligence on Spark: redaction, timelines, technology experience and hybrid search as DataFrame plans."""
