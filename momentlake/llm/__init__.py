"""Operations of a training-data pipeline: archives, chat assembly, deduplication, search, packing, scoring."""
