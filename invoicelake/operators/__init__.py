"""DataFrame to DataFrame steps of invoice processing, composed lazily with ``transform``."""
