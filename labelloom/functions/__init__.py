"""Part of labelloom; see the README for what lives here."""
