"""Operators for building training data: de-duplication, fingerprints, token counts, secrets, packing, archives."""
