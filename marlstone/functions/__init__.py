"""Part of marlstone; see the README for what lives here."""
