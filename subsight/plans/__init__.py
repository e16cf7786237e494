"""Named queries: each pairs a Spark job with the DuckDB SQL that checks it."""
