"""End-to-end jobs: ingest, alignment, cross-dataset mapping and validation, transfer and imputation."""
