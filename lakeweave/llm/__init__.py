"""Operations of a training-data pipeline: scoring, filtering, de-duplication, packing and sharding of text tables."""
