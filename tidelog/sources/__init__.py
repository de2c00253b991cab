"""Readers and writers of the tables that operators work on."""
