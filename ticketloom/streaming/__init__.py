"""ticketloom.streaming"""
