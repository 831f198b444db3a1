"""Subpackage of curata; see the README for what lives here."""
