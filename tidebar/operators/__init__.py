"""DataFrame-to-DataFrame operators on bar panels."""
