"""ticketloom.functions"""
