"""A Spark-native engine for collections of JSON documents and for building training sets from them."""

from foliospark.sources.tables import attach, release

__all__ = ["attach", "release"]
