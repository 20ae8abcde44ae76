"""Training-data operators: ten document operators and the stages of the corpus pipeline."""
