"""Part of hybridmail."""
