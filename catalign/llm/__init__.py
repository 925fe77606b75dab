"""Operators for preparing training data at scale, with their queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when the folder is present."""
