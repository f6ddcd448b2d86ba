"""Ready-made plans: input adapters, the line report and the query registry."""
