"""Tables with a composite, ordered primary key on Spark: DDL, upserts, key-range pruning and SQL."""
