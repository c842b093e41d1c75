"""Jobs over log tables: parsing, enrichment, assembly, dashboard panels."""
