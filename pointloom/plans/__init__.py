"""Plans: row order, pipelines and applications."""
