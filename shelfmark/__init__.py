"""shelfmark: a Spark-first engine for cleaning and organising very large item catalogues."""
