"""Crawl analytics on Spark: batch and streaming jobs over pages, fetch results,
progress events and job submissions."""
