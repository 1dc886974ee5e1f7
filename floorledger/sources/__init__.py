"""Raw feeds, their cleaning, and canonical ledgers over a star schema."""
