"""Streaming: designs solved as their files arrive."""
