"""Where filings come from: schema, CSV and ZIP files, catalogue and download, REST series, and a view of star-schema tables."""
