"""Multi-operator plans: serving reads, training, scoring, monitoring, ingestion, jobs."""
