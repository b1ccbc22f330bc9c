"""Operations of a large-scale text-data pipeline, as Spark jobs over `documents`-like tables."""
