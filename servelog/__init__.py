"""servelog: Spark operators over the request logs of model-serving fleets."""
