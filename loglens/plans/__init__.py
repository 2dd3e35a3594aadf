"""Reports put together from operators."""
