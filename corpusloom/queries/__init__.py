"""Registered queries: each a function of (spark, sf_dir), most with SQL for the same rows."""
