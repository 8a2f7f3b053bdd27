"""Writers: topics, CSV files, keyed upserts, documents, the dated lake."""
