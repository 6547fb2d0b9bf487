"""Online forms of the filters and of event binning."""
