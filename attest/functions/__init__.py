"""Part of attest; see README.md for the map of modules."""
