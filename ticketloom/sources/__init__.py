"""ticketloom.sources"""
