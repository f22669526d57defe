"""tarnwork: commit-corpus analytics expressed as Spark DataFrame transformations."""
