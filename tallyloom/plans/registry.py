"""All queries of the library: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from . import answers, asking, feeds, given, ingest, keeping, quality, recalling, record, scalars, search, shapes

QUERIES = {**search.QUERIES, **record.QUERIES, **quality.QUERIES, **answers.QUERIES, **scalars.QUERIES, **ingest.QUERIES, **recalling.QUERIES, **asking.QUERIES, **keeping.QUERIES, **feeds.QUERIES, **shapes.QUERIES, **given.QUERIES}
