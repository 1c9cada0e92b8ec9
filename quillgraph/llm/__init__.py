"""Training-data operators: personal data, near copies, URL lists, decontamination,
sharding, licences, mixing, chat formatting, quality rules, HTML extraction, collocations,
centroids and fingerprints.

Nothing else in the library imports this subpackage."""
