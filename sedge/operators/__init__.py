"""Operators on files, chunks, vectors, usage, subscriptions, jobs and chats."""
