"""Training-data operators: dedup, scoring, decontamination, audits, packing, sharding, scans."""
