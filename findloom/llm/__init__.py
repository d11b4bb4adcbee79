"""Training-data operators: mixing, extraction, scanning, formatting, filtering and near-duplicate detection."""
