"""Operators for preparing training data: mixing, language ID, packing,
near-duplicate search, language-model scoring, licence scans, chat formatting
and toxicity.  Nothing outside this subpackage imports it."""
