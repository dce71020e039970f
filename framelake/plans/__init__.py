"""Views that read the test tables as rasters and streams, and the queries over them."""

from framelake.plans import conversion_queries, further_queries, image_queries, place_queries, queries  # noqa: F401  all fill the registry
