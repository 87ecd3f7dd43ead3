"""Training-data pipeline operators: quality, de-duplication, mixing, packing, scoring, extraction and binary output."""
