"""See the package overview."""
