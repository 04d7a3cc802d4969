"""Sources and sinks: text files, JSON corpora, Parquet tables; and texts rendered from relational rows."""
