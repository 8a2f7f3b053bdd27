"""DataFrame operators shared by the analytics plans."""
