"""Inputs (mail files, decoded mails) and the candidate tables."""
