"""Reading tables and making seeded ones."""
