"""Writers: CSV, JSON, report tables and annotated source."""
