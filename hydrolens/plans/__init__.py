"""Entry-point jobs (prepare, enrich, train/compare, validate, tune) and the
stand-in inputs built from the benchmark tables."""
