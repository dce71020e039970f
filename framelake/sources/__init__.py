"""Sources: file listings, manifests, split lists, and binary raster formats."""
