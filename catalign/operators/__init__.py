"""DataFrame operators: similarity kernel, matching, checks, joins, reshaping, transfer, imputation, model calls."""
