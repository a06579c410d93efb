"""Readers, writers and the mapping of the driver's tables onto the CRM model."""
