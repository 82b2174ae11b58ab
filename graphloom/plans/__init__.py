"""Query catalogues, lineage cutting and other plan-level helpers."""
