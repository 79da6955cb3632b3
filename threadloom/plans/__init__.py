"""The operators put together end to end."""
