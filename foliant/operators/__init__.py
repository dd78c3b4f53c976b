"""DataFrame operators over decoded files."""
