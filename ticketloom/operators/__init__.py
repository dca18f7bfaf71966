"""ticketloom.operators"""
