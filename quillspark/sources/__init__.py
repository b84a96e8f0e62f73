"""Batches, voice packs, checks and clients in JSON files of a shared folder."""
