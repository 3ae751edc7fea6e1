"""Training-data operators: language id, decontamination, licence scans, token
counts, near-duplicate joins, passage dedup, media columns, fixity audits,
toxicity scores and mixing.  Nothing outside this subpackage imports it."""
