"""Complete queries: detection rules, enrichment, analytics and feeds."""
