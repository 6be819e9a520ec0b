"""Part of folioflow; see the package README."""
