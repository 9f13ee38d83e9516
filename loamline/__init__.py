"""loamline: hybrid retrieval over document collections as ordinary Spark plans."""
