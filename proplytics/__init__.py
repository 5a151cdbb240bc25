"""Analytics over residential property listings in Japan, as Spark jobs."""
