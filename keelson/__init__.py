"""keelson: governed, point-in-time entity analytics expressed as Spark DataFrame plans."""
