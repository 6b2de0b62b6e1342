"""tessera: log, transcript and text analytics on Spark."""
