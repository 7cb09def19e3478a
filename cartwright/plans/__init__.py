"""DataFrame-to-DataFrame plans: staging, enrichment, marts, reports, learning, retrieval."""
