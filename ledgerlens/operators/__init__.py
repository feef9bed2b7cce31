"""DataFrame operators: postings, Merkle trees, the committed dictionary, lookups, dereferencing, audits."""
