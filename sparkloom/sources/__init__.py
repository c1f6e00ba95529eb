"""Reading, ingesting and exporting datasets."""

from .io import Dataset, IngestError, export, ingest, preview, read_parquet, records

__all__ = ["Dataset", "IngestError", "export", "ingest", "preview", "read_parquet", "records"]
