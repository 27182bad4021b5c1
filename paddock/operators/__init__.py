"""DataFrame operators over league tables."""
