from datetime import datetime

from mediaspark.__main__ import main
from mediaspark.api import MediaLibrary
from mediaspark.plans.library import load

NOW = datetime(2024, 6, 1)


def test_reads_and_writes(spark, tmp_path):
    app = MediaLibrary(load(spark, "/root/testdata/sf0.001"), now=lambda: NOW)
    for name in (
        "library_stats", "knowledge_stats", "photo_grid", "persons", "timeline_buckets", "recent_runs", "recent_photos", "on_this_day",
        "hidden_duplicates", "albums", "review_count", "merge_suggestions", "all_suggestions",
    ):
        assert getattr(app, name)().columns
    for name in ("photo_detail", "photo_people", "person_profile", "appears_with", "similar_photos", "album_photos", "suggestions_for_person", "person_representatives"):
        assert getattr(app, name)(3).columns
    assert app.photos_brief([3, 1]).count() == 2 and app.photos_by_month(1997, 1).columns
    assert app.suggestion_count() == app.all_suggestions().count()
    app.set_favorite(2, True)
    assert app.library.photos.filter("id = 2 and is_favorite").count() == 1
    album = app.create_album("New")
    assert app.add_to_album(album, [1, 2]) == 2
    app.rename_album(album, "Newer")
    app.remove_from_album(album, [1])
    assert app.album_photos(album).count() == 1
    app.delete_album(album)
    app.rename_person(3, "Bo")
    face = app.all_suggestions().first()
    app.reject_suggestion(face.face_id, face.person_id)
    assert app.library.recognition_feedback.filter(f"face_id = {face.face_id} and verdict = 'reject'").count() == 1
    app.delete_person(5)
    assert app.persons().filter("id = 5").count() == 0
    app.keep_duplicate(4, [4, 5])
    app.restore_duplicate(5)
    app.dismiss_duplicate_group([4, 5])
    app.reject_merge_suggestion(2, 1)
    app.export_knowledge(str(tmp_path / "k.json"))
    assert app.restore_knowledge(str(tmp_path / "k.json"))["people"] == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gif").write_bytes(b"GIF89a\x05\x00\x06\x00")
    state = str(tmp_path / "state")
    assert main(["scan", state, str(tmp_path / "in")]) == 0
    assert "processed: 1" in capsys.readouterr().out
    assert main(["scan", state, str(tmp_path / "in")]) == 0
    assert "skipped: 1" in capsys.readouterr().out
    assert main(["scan", state, str(tmp_path / "nowhere")]) == 2 and main(["scan", state]) == 2
    assert main(["stats", state]) == 0 and main(["reset", state, "--yes"]) == 0
    assert main(["people", state]) == 0
