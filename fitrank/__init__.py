"""fitrank: matching and ranking of text records against a profile, as Spark plans."""
